import pytest

from siftline.llm import language

TEXTS = {
    "en": "The quick reader of the queue never closes the file again. Nobody knows why this happens every morning. We would like to fix it this week.",
    "de": "Der schnelle Leser der Warteschlange schließt die Datei nie wieder. Niemand weiß, warum das jeden Morgen passiert. Wir möchten es diese Woche beheben.",
    "fr": "Le lecteur rapide de la file ne ferme jamais le fichier. Personne ne sait pourquoi cela arrive chaque matin. Nous voulons le corriger cette semaine.",
}
COLUMNS = "doc_id long, text string, lang string, langs string, segments string"


def test_code_lengths_agree_with_counting():
    corpora = {"en": ["abra cadabra", "abracadabra bra"], "de": ["kabra dabra", "xyz"]}
    trees = language.ContextTrees(corpora)

    def brute(lang, text):
        data = ("\n".join(corpora[lang]) + "\n").encode()
        both = [("\n".join(corpora[k]) + "\n").encode() for k in corpora]
        import math

        def code(context, byte):
            k = len(context)
            after = [data[i + k] for i in range(len(data) - k) if data[i : i + k] == context]
            if byte in after:
                return -math.log2(after.count(byte) / (len(after) + len(set(after))))
            escape = -math.log2(len(set(after)) / (len(after) + len(set(after)))) if after else 0.0
            return escape + (code(context[1:], byte) if k else 8.0)

        assert both
        padded = b"\n" * language.ORDER + text.encode()
        return sum(code(padded[i - language.ORDER : i], padded[i]) for i in range(language.ORDER, len(padded)))

    texts = ["abra", "zebra", "dab", ""]
    got = trees.bits(texts)
    for i, t in enumerate(texts):
        for j, k in enumerate(trees.names):
            assert got[i, j] == pytest.approx(brute(k, t), rel=1e-5, abs=1e-4)


def test_sentences_leave_out_code_logs_and_names():
    text = "# The reader of foo_bar opens it.\n\nx = call(1)\n2026-01-01T00:00:00Z WARN [w1] a/b.py:1\nTwo lines make\none sentence here. OK.\nSELECT a FROM t WHERE k = ?"
    assert language.sentences(text) == ["the reader of opens it", "two lines make one sentence here"]
    assert language.sentences(None) == language.sentences("") == language.sentences(" \n ") == []


def test_sentences_beside_code_and_logs_are_kept():
    german, dutch = "der leser schließt die datei nie", "de lezer sluit het bestand nooit"
    log = "2026-06-24T23:48:45Z ERROR [w5] checkKiholodu(limit) rc=3279"
    for tail in (log, "java-path-escape\tcore/a.js\t4\t0.4", "[w7] a/b.cs ... 26/26", "2026-05-26T02:55:57Z WARN  [w5] a/b.js:3539 python-path-escape", "x = call(1);", "if (a == null) { return; }"):
        assert language.sentences(f"Der Leser schließt die Datei nie. De lezer sluit het bestand nooit. {tail}\nfoo") == [german, dutch]
    assert language.sentences(f"Der Leser schließt\ndie Datei nie. {log}\nDe lezer sluit het bestand nooit.") == [german, dutch]
    assert language.sentences("x = open(a). De lezer sluit het bestand nooit.") == [dutch]
    assert language.sentences(f"De lezer sluit {log}\nhet bestand nooit.") == ["het bestand nooit"]
    assert language.sentences("Gut so. [sic] Der Leser schließt die Datei nie. 2026-02-23 schließt der Leser nicht. x = 1")[-2:] == [german, "schließt der leser nicht"]
    for mark in ("#", "  //", " *"):
        assert language.sentences(f"x = call(1); {mark} Der Leser schließt die Datei nie. De lezer sluit het\n{mark} bestand nooit.") == [german, dutch]
    assert language.sentences(f"{log}\nx = a * b;\ny = a # b = c\nSELECT a FROM t WHERE k = ?") == []


def test_a_language_only_on_lines_with_a_log_tail_is_reported(spark):
    docs = [(i * 10 + j, TEXTS[k], k, None, None) for i, k in enumerate(TEXTS) for j in range(5)]
    docs.append((100, TEXTS["fr"] + "\n" + TEXTS["de"] + " 2026-06-24T23:48:45Z ERROR [w5] check(limit) rc=3279", "fr", "x", "y"))
    frame = spark.createDataFrame(docs, COLUMNS)
    got = language.mislabelled(language.found_languages(language.segments(frame, language.train(frame)))).collect()
    assert {(r["doc_id"], r["lang"]) for r in got} == {(100, "de"), (100, "fr")}


def test_labels():
    named = language.languages_of
    assert named("EN") == named("en-US") == named("eng") == named(" English ") == named("en_GB") == {"en"}
    assert named("de, fr") == {"de", "fr"} and named(None) == named(" ") == frozenset()
    assert named("it") != {"en"}


def test_reports_missing_wrong_and_partial_labels(spark):
    docs = [(i * 10 + j, TEXTS[k], k, None, None) for i, k in enumerate(TEXTS) for j in range(5)]
    docs += [
        (100, TEXTS["de"], None, "x", "y"), (101, TEXTS["fr"], "de", "x", "y"), (102, TEXTS["en"] + "\n\n" + TEXTS["de"], "en", "x", "y"),
        (103, "x = 1;\ny = 2;", "fr", "x", "y"), (104, None, None, None, None), (105, "", "??", None, None), (106, TEXTS["en"], "English", None, None),
        (107, (TEXTS["fr"] + "\n") * 3000, "fr", None, None),
    ]
    frame = spark.createDataFrame(docs, COLUMNS)
    of = language.segments(frame, language.train(frame))
    got = {(r["doc_id"], r["lang"]) for r in language.mislabelled(language.found_languages(of)).collect()}
    assert got == {(100, "de"), (101, "fr"), (102, "en"), (102, "de")}
    parts = {r["doc_id"]: r["segments"] for r in of.collect()}
    assert [s["lang"] for s in parts[102]] == ["en", "de"] and len(parts[107]) == 1


def test_empty_table(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert language.mislabelled(language.found_languages(language.segments(none, language.train(none)))).collect() == []


def test_a_language_that_is_not_known_is_none_of_them():
    trees = language.ContextTrees({"en": ["the rule checks that all values are there before the file is stored"] * 3, "de": ["die regel prüft dass alle werte da sind bevor die datei gespeichert wird"] * 3})
    got = trees.classify(["the rule checks that the file is there", "reguła sprawdza czy wszystkie wartości są obecne", ""])
    assert got[0][0] == "en" and got[0][1] > 0.9 and got[1] == (language.OTHER, 0.0)

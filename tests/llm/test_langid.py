import pytest

from graphloom.llm.langid import LATIN, document_languages, fit, label_language, segments, sentences, wrong_labels

TEXT = {
    "en": ["The queue should never depend on the module, because both are written by different teams.", "Please check whether the build still returns what we expect here."],
    "de": ["Die Warteschlange darf niemals von außen verändert werden, weil sonst das Ergebnis verloren geht.", "Bitte prüfe, ob das Modul noch das liefert, was wir hier erwarten."],
    "fr": ["La file ne doit jamais modifier le fichier, car les deux sont écrits par des équipes différentes.", "Vérifiez que le résultat renvoie encore ce que nous attendons ici."],
    "es": ["La cola nunca debe depender del fichero, porque los dos los escriben equipos distintos.", "Comprueba por favor si el resultado todavía devuelve lo que esperamos aquí."],
    "pt": ["A fila nunca deve depender do arquivo, porque os dois são escritos por equipes diferentes.", "Verifique por favor se o resultado ainda devolve o que esperamos aqui."],
    "nl": ["De wachtrij mag nooit van buitenaf worden gewijzigd, want dan gaat het resultaat verloren.", "Kijk even of het bestand nog steeds teruggeeft wat we hier verwachten."],
    "ru": ["Файл после слияния больше не находит результат, и никто не знает почему.", "Проверьте, пожалуйста, возвращает ли модуль то, чего мы здесь ждём."],
    "ja": ["以前の動作は分かりやすかったのですが、行が失われていました。", "この節ではキューと解析器の関係を説明します。"],
}
MODEL = fit([(x, " ".join(TEXT[x])) for x in LATIN for _ in range(3)])


@pytest.mark.parametrize("lang", TEXT)
def test_sentences_have_their_language(lang):
    found = sentences("\n".join(TEXT[lang]))
    assert [x for x, _ in MODEL.label([w for _, _, w in found])] == [lang] * 2
    assert all(0 < sure <= 1 for _, sure in MODEL.label([w for _, _, w in found]))


def test_words_common_in_a_language_do_without_a_sample():
    empty = fit([])
    found = sentences("It is not the same as that one was.\nDas ist nicht das, was man noch bei uns hat.")
    assert [x for x, _ in empty.label([w for _, _, w in found])] == ["en", "de"]


@pytest.mark.parametrize(
    ("label", "lang"),
    [("en", "en"), ("EN", "en"), ("en_GB", "en"), (" pt-BR ", "pt"), ("Deutsch", "de"), ("ger", "de"), ("fre", "fr"), ("日本語", "ja"), ("und", None), ("", None), (None, None), ("zh", None), ("python", None)],
)
def test_labels(label, lang):
    assert label_language(label) == lang


def test_only_whole_sentences_count():
    text = "\n".join(
        [
            "## A heading about the queue and the module", "Thanks!", "2025-10-02T12:50:07Z WARN chunk::build took=960ms.", 'File "a/b.py", line 3, in the module.', "```py", "This is a comment in a fence, not a sentence.", "```",
            "foo(bar); baz(qux);", "feat(x): " + TEXT["en"][0], "- " + TEXT["de"][1] + " 🚀", "1. `code_here` " + TEXT["fr"][0], "no end of a sentence here", "~~~", "Unclosed fence with a whole sentence in it.",
        ]
    )
    found = sentences(text)
    assert [x for x, _ in MODEL.label([w for _, _, w in found])] == ["en", "de", "fr"]
    for a, b, _ in found:
        assert text[a:b].strip() == text[a:b] and text[b - 1] == "."


def test_decomposed_letters_and_blanks_without_width():
    import unicodedata

    text = unicodedata.normalize("NFD", TEXT["fr"][0]) + "\u200b " + TEXT["fr"][1].replace(" ", "\xa0")
    assert [x for x, _ in MODEL.label([w for _, _, w in sentences(text)])] == ["fr", "fr"]


def test_long_texts_are_read_to_the_end():
    text = "\n".join([TEXT["en"][0]] * 2000 + TEXT["nl"])
    labels = [x for x, _ in MODEL.label([w for _, _, w in sentences(text)])]
    assert labels == ["en"] * 2000 + ["nl"] * 2


def test_operator(spark):
    two = lambda x: " ".join(TEXT[x])
    rows = [(k, x, two(x)) for k, x in enumerate(TEXT)] + [
        (20, None, two("de")), (21, "en", two("fr")), (22, "English", two("en") + "\n\n" + two("nl")), (23, "en", two("en") + " " + TEXT["nl"][0]), (24, "xx", "x = 1;"), (25, None, None), (26, "en", ""), (27, "en", "  "),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").selectExpr("*", "1 as segment", "'x' as label")
    found = segments(docs)
    got = sorted((r.doc_id, r.lang) for r in wrong_labels(document_languages(found)).collect())
    assert got == [(20, "de"), (21, "fr"), (22, "en"), (22, "nl")]
    s = {(r.doc_id, r.segment): (r.lang, r.sentences) for r in found.collect()}
    assert s[22, 0] == ("en", 2) and s[22, 1] == ("nl", 2) and s[23, 1] == ("nl", 1) and not any(d >= 24 for d, _ in s)
    assert segments(docs.limit(0)).collect() == []
